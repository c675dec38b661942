"""The queries of this subpackage: thin wrappers that derive contract columns from the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, embeddings, extraction, language, mixing, packing, pii, ranked, secrets, simhash, sketches, toxicity, warc
from .common import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archive(_table(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "verified")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))
    return found.withColumn("probability", F.round("probability", 6))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(_table(spark, sf_dir, "documents"))
    base = [r.kind for r in secrets.BASE_RULES]

    def spans(rows):
        return F.array_join(F.transform(rows, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, base), F.sha2(spans(F.filter("findings", lambda f: f["kind"].isin(base))), 256).alias("base_sha256"), spans(F.col("findings")).alias("spans"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def surrogate_key(spark: SparkSession) -> bytes:
    """The secret of the surrogates, from the setting spark.quill.pii.key; the test tables, whose
    persons are invented, have a public one."""
    return spark.conf.get("spark.quill.pii.key", "public key of the test tables").encode()


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = pii.pseudonymized(_table(spark, sf_dir, "documents").select("doc_id", "text"), surrogate_key(spark))
    spans = F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e["kind"], e["start"].cast("string"), e["end"].cast("string"))), ",")
    return new.select("doc_id", "text", F.size("entities").cast("bigint").alias("n_entities"), spans.alias("spans"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.decisions(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "lang", "topic", "tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "kept")


def op10_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sketches.compare_versions(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.char_length("text").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        sketches.written(F.col("cells")).alias("fingerprint"),
        sketches.written(F.col("edited_cells")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster(_table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extraction.extract(_table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.char_length("text").cast("bigint"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ranked.build_index(_table(spark, sf_dir, "documents"), scratch_path(spark, "index"))
    return ranked.search(index, _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_round_trip": op1_warc_round_trip,
    "op2_toxicity": op2_toxicity,
    "op3_language_id": op3_language_id,
    "op4_secret_scan": op4_secret_scan,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_packing": op7_packing,
    "op8_pii_surrogates": op8_pii_surrogates,
    "op9_source_mixing": op9_source_mixing,
    "op10_iblt_fingerprints": op10_iblt_fingerprints,
    "op11_centroids": op11_centroids,
    "op12_html_extraction": op12_html_extraction,
    "op13_ranked_search": op13_ranked_search,
}

OP1_SQL = """
WITH p AS (SELECT page_id, regexp_replace(coalesce(url, ''), '[\\x00-\\x20\\x7f]+', '%20', 'g') AS url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, url, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to, url, page_id = first AS verified
FROM f
"""

ORACLE_SQL: dict[str, str] = {"op1_warc_round_trip": OP1_SQL, "op9_source_mixing": mixing.oracle_sql(), "op11_centroids": centroids.oracle_sql(), "op13_ranked_search": ranked.oracle_sql()}
