"""Named queries of the training-data operators and the SQL that can state them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moundworks.llm import (
    alignment, block_search, byte_bpe, cross_parsing, metric_join, packing, privacy, repeats, simhash,
    threshold_centroids, token_counts, token_file, toxicity)
from moundworks.llm.common import read_table

BYTE_BPE = "byte_bpe_50k.json"
BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096


def op1_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.summary(privacy.find(spark, read_table(spark, sf_dir, "documents")))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return token_file.token_files(spark, docs, public_tokenizers.path(BYTE_BPE), added_tokens=True)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ranks = read_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_RANKS)
    encoded = byte_bpe.encode(spark, docs, ranks, public_tokenizers.PATTERN)
    return byte_bpe.digest(encoded, ranks)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_copies(spark, read_table(spark, sf_dir, "documents"))
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


def op5_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.near_vectors(spark, read_table(spark, sf_dir, "embeddings"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.repeated_spans(spark, read_table(spark, sf_dir, "documents")))


def _remainder(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    scored = toxicity.score(spark, docs, labels, _remainder(5) != 0)
    return scored.select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", "predicted")


def op8_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = cross_parsing.identify(spark, docs, _remainder(3) != 1)
    return found.select("doc_id", (_remainder(3) == 1).alias("held_out"), "lang_pred", "score")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return packing.pack(spark, docs, public_tokenizers.path(BYTE_BPE), added_tokens=True)


def op10_block_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return block_search.nearest(spark, vectors, F.col("vec_id") % 50 == 0)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(
        spark, read_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op12_threshold_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_centroids.digest(
        *threshold_centroids.cluster(spark, read_table(spark, sf_dir, "embeddings")))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    paths = public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECES)
    return alignment.PairTable(spark, docs, *paths).aligned()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def centroid_sql(k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: str = "3") -> str:
    """The clustering in SQL, one pair of expressions per round."""
    named = [f"""v0 AS MATERIALIZED (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings
        WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size})""",
        f"""c0 AS MATERIALIZED (
        SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS cluster, v AS c FROM (
            SELECT v, sha256('{seed}:' || CAST(vec_id AS VARCHAR)) AS h FROM v0 ORDER BY h LIMIT {k}))"""]
    distance = f"list_sum(list_transform(range(1, {size} + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i])))"
    for i in range(rounds + 1):
        named.append(f"""a{i} AS MATERIALIZED (
        SELECT vec_id, any_value(v) AS v, min(d) AS distance, arg_min(cluster, (d, cluster)) AS cluster
        FROM (SELECT vec_id, v, cluster, CAST({distance} AS BIGINT) AS d FROM v0 CROSS JOIN c{i}) GROUP BY vec_id)""")
        if i < rounds:
            named.append(f"""c{i + 1} AS MATERIALIZED (
        SELECT cluster, coalesce(n.c, old.c) AS c FROM c{i} AS old LEFT JOIN (
            SELECT cluster, list(s // n - CASE WHEN s % n < 0 THEN 1 ELSE 0 END ORDER BY dim) AS c FROM (
                SELECT cluster, dim, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (
                    SELECT cluster, unnest(v) AS x, unnest(range({size})) AS dim FROM a{i}) GROUP BY cluster, dim)
            GROUP BY cluster) AS n USING (cluster))""")
    return f"""WITH {", ".join(named)}
    SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
           CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
    FROM a{rounds} JOIN c{rounds} USING (cluster)"""


def oracle_sql() -> dict[str, str]:
    return {"op12_threshold_centroids": centroid_sql()}
