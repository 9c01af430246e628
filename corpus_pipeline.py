"""A corpus from raw documents to packed sequences, in stages that read what the one before kept.

Each stage takes (spark, docs, sf_dir) and works on all rows it is given; all but the last return
the columns of ``documents``. Texts that change get their ``n_chars`` anew. Rows with a null or empty
text go with the first stage, as no language can be told; later stages keep empty texts.

Stages set the session's Arrow batches to ``BATCH_ROWS`` rows, as a row is a whole document.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moundworks.llm import cross_parsing, packing, privacy, repeats, simhash
from moundworks.llm.common import Stages

#: A text whose phrases are shorter than two letters on average is in no language that was learned.
UNREADABLE = 0.5
TOKENIZER = "byte_bpe_50k.json"
BATCH_ROWS = 1_000


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and texts that no learned language can parse."""
    _small_batches(spark)
    learn_from = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1
    # columns of other uses may have the names of the predictions
    names = [c if c in ("doc_id", "text", "lang") else f"other_{i}" for i, c in enumerate(docs.columns)]
    found = cross_parsing.identify(spark, docs.toDF(*names), learn_from, tuple(names))
    read = (F.col("lang_pred") != cross_parsing.UNDETERMINED) & (F.col("phrases_per_letter") <= UNREADABLE)
    return found.where(read).select(*names).toDF(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that SimHash links join: the row of the smallest id, rows without
    an id last, and of several rows of that id the one of the smallest text hash.

    A text takes part under its 64-bit hash, so rows are decided one by one, whatever their ids; rows of
    one id and text are copies.
    """
    _small_batches(spark)
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    found = simhash.near_copies(spark, docs.select(key.alias("doc_id"), "text"))
    group = found.groupBy(F.col("doc_id").alias("key")).agg(F.min("component_id").alias("component"))
    copies = docs.groupBy("doc_id", key.alias("key")).agg(F.count("*").alias("n"))
    stay = copies.join(group, "key").groupBy("component").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", "n")).alias("low")).select("low.*")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
                       F.col("doc_id").alias("own_id"), key.alias("own_key"))
    kept = rows.join(stay, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_key") == F.col("key")))
    once = kept.where("n = 1").unionByName(kept.where("n > 1").dropDuplicates(["own_id", "own_key"]))
    return once.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages out that a document with a smaller id has too."""
    _small_batches(spark)
    return _counted(repeats.without_repeats(repeats.repeated_spans(spark, docs)))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of its kind."""
    return _counted(privacy.mask(spark, docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all texts, cut into sequences."""
    _small_batches(spark)
    return packing.pack(spark, docs, public_tokenizers.path(TOKENIZER), keep_ids=True, added_tokens=True)


STAGES = [
    ("language", languages), ("near_copies", near_copies), ("repeats", repeated_passages),
    ("personal_data", personal_data), ("packing", packed),
]
#: No stage can be stated in SQL; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = Stages(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = stages.write(name, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
