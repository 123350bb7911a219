"""A training corpus from raw documents: quality rules, near-duplicates, secrets, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``docs``. ``run`` writes every stage's result as Parquet in the shared folder and gives
what it reads back to the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolgrid.llm import bpe, mixing, neardup, outliers, secret_ledger
from symbolgrid.llm.durable import Store


def _only(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of docs whose (doc_id, content) is in ``wanted``; texts are hashed, not sorted. A task
    holds the distinct pairs of its partition, two numbers for each of the texts that it streams."""
    keys = wanted.select(F.col("doc_id").alias("wanted_id"), F.col("content").alias("wanted_content")).distinct()
    content = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    same = docs["doc_id"].eqNullSafe(F.col("wanted_id")) & (content == F.col("wanted_content"))
    return docs.join(keys.hint("shuffle_hash"), same, "left_semi")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the robust outlier rules (7) reject go."""
    return _only(docs, outliers.judge(spark, docs).filter("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component (8) stays: of the smallest doc_id, and if that
    id has several texts in the component, the one of smallest hash. Texts without words all stay.
    Repeated rows of what stays become one."""
    found = neardup.near_duplicates(spark, docs).filter("kept")
    wordless = found.filter("component is null").select("doc_id", "content")
    one = found.filter("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "content")).alias("one"))
    rows = _only(docs, wordless.unionByName(one.select("one.*")).distinct())
    return rows.dropDuplicates(["doc_id", "text"])


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets that the blob ledger (9) finds are masked; every document stays."""
    ledger = Store(spark, "ledger").put("findings", secret_ledger.update_ledger(docs))
    return secret_ledger.redact_paths(docs, ledger)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled at the raked rates of their source, language and topic (3); those of
    scarce cells are repeated."""
    wanted = mixing.sample(spark, docs).filter("selected")
    keys = wanted.select(F.col("doc_id").alias("wanted_id"), F.col("content").alias("wanted_content"), F.col("copies").alias("wanted_copies")).distinct()
    content = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    same = docs["doc_id"].eqNullSafe(F.col("wanted_id")) & (content == F.col("wanted_content"))
    rows = docs.join(keys.hint("shuffle_hash"), same)
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("wanted_copies"))).alias("wanted_time")
    return rows.select(*[docs[c] for c in docs.columns], times).drop("wanted_time")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document (10), with digests of the ids and of what they decode to."""
    import public_tokenizers

    codec = bpe.load_codec(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.encode_column(docs, codec)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("secret scan", secret_scan),
    ("source mixing", mix_sources),
    ("tokens", tokens),
]

#: Outlier estimates, raking and merges are iterative: SQL cannot express the rows of run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = store.put(f"stage{k}", stage(spark, docs, sf_dir))
    return docs
