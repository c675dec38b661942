"""Web archives: writing WARC records, and reading them with boundary-chain verification.

Archives are plain text files of Spark's writer, a record a row; the record separator of the format
(two line ends) is the row separator. They are read as rows that end at the record magic, so Spark
splits files by byte ranges. Every row is a candidate record: its place in the file and its
declared length give its successor's place. Magic within a payload makes candidates too.

Only what is reachable from a file's start is a record. Candidates whose successor is simply the
next candidate form runs, which are contracted by a window; the rest, at which a run breaks, jump.
Pointer jumping doubles the jumps in each round until no new run is reached, so the rounds grow
with the logarithm of the number of breaks in a file (one in a file without magic in payloads).

Payloads that hold magic are spread over several rows; those rows are fetched again by digest and
put together.

Defined cases: a null html is an empty payload, a null url an empty one; rows with a null page_id
are written without an id and come after all others in the choice of a response; where rows repeat
the smallest page_id of equal payloads, one with the smallest url is the response and the others
revisit it; an empty table gives an empty archive and result; other columns are ignored. White space and control characters of a url are
written as %20.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import sized_join, staged

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 100
DATE = "2024-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def write_archive(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> None:
    """Write a record for each row of page_id, url, html to new files in the folder ``path``.

    Of equal payloads of at least ``least_bytes`` bytes the one with the smallest page_id becomes
    a response, the others revisits of it; all other records are responses.
    """
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\x00-\x20\x7f]+", "%20").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    digest = F.sha2("html", 256).alias("digest")
    firsts = rows.where(F.octet_length("html") >= least_bytes).select("page_id", digest).groupBy("digest")
    firsts = staged(firsts.agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "firsts")
    rows = sized_join(rows.withColumn("digest", digest), firsts.withColumn("copied", F.lit(True)), ["digest"], "left")
    first = F.coalesce("copied", F.lit(False)) & F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.withColumns({"revisit": F.coalesce("copied", F.lit(False)) & ~first, "bytes": F.octet_length("html")})
    columns = ["page_id", "url", "digest", "first", "revisit", "bytes", "html"]
    # rows that repeat the smallest page_id are alike but for the url: they are written by their count
    by_url = staged(rows.where(first).groupBy("digest", "url").agg(F.count("*").alias("n")), "firsts")
    repeated = staged(by_url.groupBy("digest").agg(F.min("url").alias("lead"), F.sum("n").alias("n")).where("n > 1").select("digest", "lead"), "repeated")
    if repeated.limit(1).count():
        held = sized_join(rows.where(first), repeated, ["digest"])
        alike = held.groupBy("digest", "url", "lead", "page_id", "first", "bytes").agg(F.first("html").alias("html"), F.count("*").alias("n"))
        alike = alike.withColumn("i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n")))).withColumn("revisit", (F.col("url") != F.col("lead")) | (F.col("i") > 1))
        rest = sized_join(rows.withColumn("is_first", first), repeated.withColumn("is_first", F.lit(True)), ["digest", "is_first"], "left_anti")
        rows = rest.select(columns).union(alike.select(columns))
    revisit = F.col("revisit")
    block = F.concat(F.lit(HTTP), F.col("bytes").cast("string"), F.lit(END), F.when(revisit, F.lit("")).otherwise(F.col("html")))
    record = F.concat(
        F.lit(f"{MAGIC}WARC-Type: "),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.coalesce(F.concat(F.lit("\r\nWARC-Record-ID: <urn:page:"), F.col("page_id").cast("string"), F.lit(">")), F.lit("")),
        F.lit("\r\nWARC-Target-URI: "),
        F.col("url"),
        F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Payload-Digest: sha256:"),
        F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(f">\r\nWARC-Profile: {PROFILE}"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "),
        F.octet_length("block").cast("string"),
        F.lit(END),
        F.col("block"),
    )
    rows.withColumn("block", block).select(record.alias("value")).write.option("lineSep", END).text(path)


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """What lies between magics, with its file, the byte range it was read from, and its order."""
    rows = spark.read.option("lineSep", MAGIC).text(path)
    return rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"))


def _header(head: Column, name: str, value: str = r"[^\r\n]*") -> Column:
    return F.regexp_extract(head, rf"(?i)(?:^|\n){name}: *({value})", 1)


def _after(text: Column, head: Column) -> Column:
    """What follows a head and the empty line after it."""
    return F.substring(text, F.char_length(head) + 1 + len(END), F.lit(1 << 30))


def _parsed(chunks: DataFrame) -> DataFrame:
    """Narrow columns of every chunk: its size, the size its record declares, header fields, and
    for records that lie within the chunk the payload's size and digest."""
    rows = chunks.withColumn("head", F.substring_index("value", END, 1))
    length = _header(F.col("head"), "Content-Length", "[0-9]+").try_cast("bigint")
    size = F.octet_length("value").cast("bigint") + len(MAGIC)
    record = F.octet_length("head") + 2 * len(END) + length + len(MAGIC)
    rows = rows.withColumn("size", size).withColumn("record", F.when(F.instr("value", END) > 0, record))
    rows = rows.withColumn("block_text", F.when(F.col("record") == F.col("size"), _after(F.col("value"), F.col("head"))))
    return rows.select(
        "file", "block", "nth", "size", "record",
        F.md5("value").alias("piece"),
        *_fields(),
    )


def _fields() -> list[Column]:
    head = F.col("head")
    return [
        _header(head, "WARC-Type").alias("record_type"),
        _header(head, "WARC-Record-ID").alias("record_id"),
        _header(head, "WARC-Target-URI").alias("url"),
        _header(head, "WARC-Refers-To").alias("refers"),
        _header(head, "WARC-Payload-Digest").alias("declared"),
        *_payload(F.col("block_text")),
    ]


def _payload(block: Column) -> list[Column]:
    """Size and digest of the payload in a record's block and its end mark, and the size that the
    block's own head declares."""
    http = F.substring_index(block, END, 1)
    payload = F.substring(block, F.char_length(http) + 1 + len(END), F.char_length(block) - F.char_length(http) - 2 * len(END))
    return [
        F.octet_length(payload).cast("bigint").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_digest"),
        _header(http, "Content-Length", "[0-9]+").alias("http_length"),
    ]


def _placed(rows: DataFrame) -> DataFrame:
    """Chunks with the offset in their file at which their magic starts: chunks cover a file, so
    those before add up to it, within a byte range and over the ranges before."""
    before = Window.partitionBy("file", "block").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("file", "block").agg(F.sum("size").alias("bytes"))
    over = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.coalesce(F.sum("bytes").over(over), F.lit(0)).alias("base"))
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(before), F.lit(0)))
    return rows.join(blocks, ["file", "block"]).withColumn("at", F.col("base") + F.col("within") - len(MAGIC))


def _reached(candidates: DataFrame) -> DataFrame:
    """file, last (a run's last candidate) and entry (where the chain enters it), for every run
    that is reachable from its file's start."""
    starts = candidates.select("file", "at", "last")
    ends = candidates.where("at = last").select("file", "at", "next")
    jumps = ends.join(starts.withColumnRenamed("at", "next").withColumnRenamed("last", "to"), ["file", "next"]).select("file", F.col("at").alias("node"), "next", "to")
    jumps = staged(jumps, "jumps")
    reached = staged(starts.where("at = 0").select("file", F.col("last").alias("node")), "reached")
    hops = jumps.select("file", "node", "to")
    known = reached.count()
    while True:
        reached = staged(reached.union(reached.join(hops, ["file", "node"]).select("file", F.col("to").alias("node"))).distinct(), "reached")
        now = reached.count()
        if now == known:
            break
        known = now
        hops = staged(hops.join(hops.select("file", F.col("node").alias("to"), F.col("to").alias("far")), ["file", "to"]).select("file", "node", F.col("far").alias("to")), "hops")
    entries = jumps.join(reached, ["file", "node"]).select("file", F.col("to").alias("last"), F.col("next").alias("entry"))
    return entries.union(starts.where("at = 0").select("file", "last", F.lit(0).cast("bigint").alias("entry")))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record that is reachable from the start of one of the files in ``path``:
    file, at, page_id, url, record_type, refers_to, payload_bytes, payload_digest (of the full
    payload) and verified (the digest was computed from the payload read; revisits carry none).
    """
    rows = staged(_placed(staged(_parsed(_chunks(spark, path)), "chunks")), "placed")
    order = Window.partitionBy("file").orderBy("at")
    candidates = rows.where("record IS NOT NULL AND at >= 0").select("file", "at", (F.col("at") + F.col("record")).alias("next"))
    candidates = candidates.withColumn("breaks", ~F.col("next").eqNullSafe(F.lead("at").over(order)))
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    candidates = staged(candidates.withColumn("last", F.min(F.when(F.col("breaks"), F.col("at"))).over(rest)), "candidates")
    found = candidates.join(_reached(candidates), ["file", "last"]).where("at >= entry").select("file", "at", "next")
    records = staged(rows.join(found, ["file", "at"]), "records")

    spread = records.where("payload_digest IS NULL").select("file", "at", "next")
    if spread.limit(1).count():
        # by range: the pieces of a record are the chunks from its place to its successor's
        mark = F.when(F.col("start"), F.struct("at", "next"))
        all_rows = rows.select("file", "at", "piece", F.lit(False).alias("start"), F.lit(None).cast("bigint").alias("next"))
        marks = spread.select("file", "at", F.lit(None).cast("string").alias("piece"), F.lit(True).alias("start"), "next")
        over = Window.partitionBy("file").orderBy("at", F.desc("start")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        pieces = all_rows.union(marks).withColumn("of", F.last(mark, ignorenulls=True).over(over)).where("NOT start AND at < of.next")
        pieces = staged(pieces.select("file", F.col("of.at").alias("record_at"), "at", "piece"), "pieces")
        texts = sized_join(_chunks(spark, path).select("value", F.md5("value").alias("piece")), staged(pieces.select("piece").distinct(), "wanted"), ["piece"], "left_semi").dropDuplicates(["piece"])
        joined = pieces.join(texts, "piece").groupBy("file", "record_at").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("parts"))
        text = F.array_join(F.transform("parts", lambda p: p["value"]), MAGIC)
        whole = joined.select("file", F.col("record_at").alias("at"), text.alias("value")).withColumn("head", F.substring_index("value", END, 1))
        whole = whole.withColumn("block_text", _after(F.col("value"), F.col("head"))).select("file", "at", *_payload(F.col("block_text")))
        names = ["payload_bytes", "payload_digest", "http_length"]
        whole = staged(whole.select("file", "at", *[F.col(n).alias(f"whole_{n}") for n in names]), "whole")
        records = sized_join(records, whole, ["file", "at"], "left").withColumns({n: F.coalesce(n, f"whole_{n}") for n in names})

    revisit = F.col("record_type") == "revisit"
    declared = F.regexp_extract("declared", "^sha256:([0-9a-f]{64})$", 1)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '([0-9]+|-[0-9]+)>', 1) AS bigint)")
    return records.select(
        "file", "at",
        number("record_id").alias("page_id"),
        "url", "record_type",
        F.when(revisit, number("refers")).alias("refers_to"),
        F.when(revisit, F.expr("try_cast(http_length AS bigint)")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, declared).otherwise(F.col("payload_digest")).alias("payload_digest"),
        (~revisit & (declared == F.col("payload_digest"))).alias("verified"),
    )
