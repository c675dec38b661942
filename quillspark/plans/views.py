"""The test tables as the store's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def thoughts(spark: SparkSession, sf_dir: str, vectors: bool = True, labels: bool = True) -> DataFrame:
    """Documents with labels and vectors; those that a query does not use are not joined."""
    rows, none = table(spark, sf_dir, "documents"), F.lit(None).cast("int")
    rows = rows.join(table(spark, sf_dir, "labels"), "doc_id", "left") if labels else rows.withColumns({"quality": none, "toxic": none})
    if vectors:
        rows = rows.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    return rows.select(
        F.col("doc_id").alias("serial_id"), F.col("text").alias("content"), F.col("lang").alias("type"), F.col("source").alias("source_type"),
        (1 + F.col("doc_id") % 5).cast("int").alias("importance"), (F.col("quality") * 100).alias("quality_score"),
        F.when(F.col("toxic") == 1, "restricted").when(F.col("toxic") == 0, "standard").alias("sensitivity_tier"),
        (F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.col("doc_id").cast("int"))).alias("created_at"), *(["embedding"] if vectors else []),
    )


THOUGHTS_SQL = """thoughts AS (
  SELECT d.doc_id AS serial_id, d.text AS content, d.lang AS type, d.source AS source_type, (1 + d.doc_id % 5)::INT AS importance, l.quality * 100 AS quality_score,
         CASE l.toxic WHEN 1 THEN 'restricted' WHEN 0 THEN 'standard' END AS sensitivity_tier,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(d.doc_id::INT) AS created_at, e.embedding
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as thoughts, suppliers as entities."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("thought_id"), F.col("l_suppkey").alias("entity_id")).distinct()


LINKS_SQL = "links AS (SELECT DISTINCT l_orderkey AS thought_id, l_suppkey AS entity_id FROM lineitem)"


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("person"), F.lit("tool"), F.lit("topic")), (F.col("s_nationkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), kind.alias("entity_type"), F.array(F.lower("s_name")).alias("aliases"))


def entity_thoughts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as thoughts with a class and a time."""
    by = F.when(F.col("o_orderstatus") == "F", "work").when(F.col("o_orderstatus") == "O", "personal")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), by.alias("classification"), F.col("o_orderdate").alias("created_at"))


ENTITY_THOUGHTS_SQL = "entity_thoughts AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'work' WHEN 'O' THEN 'personal' END AS classification, o_orderdate AS created_at FROM orders)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that meet in an order's neighbouring lines, as edges between entities."""
    rows = table(spark, sf_dir, "lineitem")
    a = rows.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("a"))
    b = rows.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_suppkey").alias("b"), F.col("l_returnflag").alias("relation"))
    both = a.join(b, ["l_orderkey", "l_linenumber"]).where("a <> b")
    return both.groupBy(F.col("a").alias("from_entity_id"), F.col("b").alias("to_entity_id"), "relation").agg(F.count("*").alias("support_count"))


EDGES_SQL = "edges AS (SELECT a.l_suppkey AS from_entity_id, b.l_suppkey AS to_entity_id, b.l_returnflag AS relation, count(*) AS support_count FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber - 1 WHERE a.l_suppkey <> b.l_suppkey GROUP BY ALL)"


def _pick(values: list[str | None], n: str = "doc_id") -> str:
    """The value at doc_id modulo the number of values; the same in both dialects."""
    return f"CASE {n} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v is not None) + " END"


#: Columns of notes in SQL that Spark and DuckDB read alike.
_NOTES = {
    "id": "doc_id", "serial_id": "doc_id", "content": "text", "source_type": "source", "importance": "1 + doc_id % 5", "quality_score": "doc_id % 101",
    "type": _pick(["idea", "task", "person_note", "reference", "decision", "lesson", "meeting", "journal", None]), "status": _pick(["new", "planning", "active", "review", "done", "odd", None]),
    "sensitivity_tier": _pick(["standard", "personal", "restricted", None]), "classification": _pick(["work", "personal", None]), "review_status": _pick(["pending_review", "approved", None, None, None]),
    "generated_by": _pick([None, None, None, None, "digest"]),
}


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a store's thoughts: all columns follow from doc_id, text and source."""
    n = F.col("doc_id")
    name = lambda p, m: F.concat(F.lit(p), (n % m).cast("string"))
    tags = F.transform(F.sequence(F.lit(1).cast("bigint"), F.greatest(F.lit(1).cast("bigint"), n % 14)), lambda i: F.concat(F.lit("g"), i.cast("string")))
    none = F.array().cast("array<string>")
    return table(spark, sf_dir, "documents").selectExpr("doc_id", *[f"{v} AS {k}" for k, v in _NOTES.items()]).withColumns({
        "created_at": F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), n.cast("int")),
        "topics": F.when(n % 6 != 0, F.array_distinct(F.array(name("t", 11), name("t", 5)))).otherwise(none), "people": F.when(n % 2 == 0, F.array(name("p", 13))).otherwise(none),
        "tags": F.when(n % 14 > 0, tags).otherwise(none), "action_items": F.when(n % 4 == 0, F.array(F.concat(F.lit("call "), n.cast("string")), F.concat(F.lit("write "), n.cast("string")))),
    }).drop("doc_id")


NOTES_SQL = f"""notes AS (SELECT {', '.join(f'{v} AS {k}' for k, v in _NOTES.items())}, TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id::INT) AS created_at,
  CASE WHEN doc_id % 6 <> 0 THEN CASE WHEN doc_id % 11 = doc_id % 5 THEN ['t' || doc_id % 11] ELSE ['t' || doc_id % 11, 't' || doc_id % 5] END ELSE []::VARCHAR[] END AS topics,
  CASE WHEN doc_id % 2 = 0 THEN ['p' || doc_id % 13] ELSE []::VARCHAR[] END AS people, list_transform(range(1, doc_id % 14 + 1), lambda i: 'g' || i) AS tags,
  CASE WHEN doc_id % 4 = 0 THEN ['call ' || doc_id, 'write ' || doc_id] END AS action_items FROM documents)"""
