"""The corpus pipeline: toxicity, SimHash near-duplicates, personal data, mixing, packing.

Every stage takes what its predecessor kept, written as Parquet and read again; all but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import mixing, packing, pii, simhash, toxicity
from quillspark.llm.common import drop_path, scratch_path, sized_join, staged
from quillspark.llm.queries import surrogate_key, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return model.score(docs, tuple(COLUMNS)).where("score < 0.5").select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) one row: the one
    with the smallest doc_id, then text hash; rows without a doc_id come last. Of rows that repeat
    both, the smallest by the other columns."""
    docs = docs.select(COLUMNS)
    no_id = F.coalesce("doc_id", F.lit(0).cast(docs.schema["doc_id"].dataType))
    key = F.struct(F.isnull("doc_id").alias("last"), no_id.alias("id"), F.coalesce(F.sha2("text", 256), F.lit("")).alias("hash"))
    found = staged(simhash.similar_documents(docs.select(key.alias("doc_id"), "text")), "rows")
    copies = staged(found.where("doc_id <> component_id").select(F.col("doc_id").alias("row")).distinct(), "copies")
    kept = found.where("doc_id = component_id").groupBy(F.col("doc_id").alias("row")).count()
    repeated = staged(kept.where("count > 1").select("row"), "repeated")
    rows = sized_join(docs.withColumn("row", key), copies, ["row"], "left_anti")
    if not repeated.limit(1).count():
        return rows.select(COLUMNS)
    once = sized_join(rows, repeated, ["row"], "left_semi").groupBy("row").agg(F.min(F.struct(COLUMNS)).alias("first"))
    return sized_join(rows, repeated, ["row"], "left_anti").select(COLUMNS).unionByName(once.select("first.*"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data."""
    new = pii.pseudonymized(docs.select(COLUMNS), surrogate_key(spark))
    return new.withColumn("n_chars", F.char_length("text").cast("bigint")).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the raked token shares of source, language and topic."""
    mixed = mixing.mix(docs.select(*COLUMNS), keep=["lang", "source", "n_chars"]).where("kept")
    return mixed.select("doc_id", "text", F.col("kept_lang").alias("lang"), F.col("kept_source").alias("source"), F.col("kept_n_chars").alias("n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in the training sequences."""
    pieces = packing.pack_documents(docs, tokenizer_path(), cache_entries=250_000)  # its workers have been through other stages
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("pii_surrogates", replace_personal_data),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No stage's model, fingerprints or tokens can be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder, each written and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
