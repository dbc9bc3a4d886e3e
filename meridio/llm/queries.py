"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridio.llm import (
    bucket_topk,
    histogram_shards,
    pca_dedup,
    pitman_yor,
    simhash_dedup,
    subsequence_toxicity,
    subword_quality,
    temperature_mix,
    vector_packing,
    warc_dictionary,
)
from meridio.llm.common import remainder

QUALITY_FROM, TOXIC_FROM = 0.3, 0.5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _judged(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = subword_quality.train(docs, table(spark, sf_dir, "labels"))
    return _judged(subword_quality.score_documents(docs, model), QUALITY_FROM)


def op2_bucket_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucket_topk.top_k(table(spark, sf_dir, "embeddings"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = histogram_shards.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), 24)
    return placed.select(
        "doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op5_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score_documents(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_subsequence_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = subsequence_toxicity.train(docs, table(spark, sf_dir, "labels"))
    return _judged(subsequence_toxicity.score_documents(docs, machine), TOXIC_FROM)


def op7_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = temperature_mix.mix(table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id", "source", F.col("mix_tokens").alias("tokens"), F.col("mix_weight").alias("weight"), F.col("mix_epoch").alias("epoch"), F.col("mix_block").alias("block"), F.col("mix_at").alias("place")
    )


def op8_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_dictionary.archive_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = vector_packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), keep_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_pca_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pca_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def queries():
    found = (op1_subword_quality, op2_bucket_topk, op3_simhash_dedup, op4_histogram_shards, op5_pitman_yor, op6_subsequence_toxicity, op7_temperature_mix, op8_warc_dictionary, op9_vector_packing, op10_pca_dedup)
    out = {f.__name__: f for f in found}

    def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
        import corpus_pipeline

        return corpus_pipeline.run(spark, sf_dir)

    return out | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_bucket_topk": """
            WITH v AS (
                SELECT vec_id, min(list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT))) AS q
                FROM embeddings
                WHERE embedding IS NOT NULL AND len(embedding) > 0
                  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                GROUP BY vec_id
            ), s AS (
                SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
                FROM v a JOIN v b ON a.vec_id <> b.vec_id
                WHERE a.vec_id % 20 = 0
            ), r AS (
                SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
            )
            SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
        "op8_warc_dictionary": """
            WITH p AS (
                SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
            ), f AS (
                SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p
            )
            SELECT page_id, payload_bytes, payload_digest,
                   CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
                   CASE WHEN first <> page_id THEN first END AS refers_to
            FROM f""",
        "op10_pca_dedup": """
            WITH RECURSIVE v AS (
                SELECT vec_id, min(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS e FROM embeddings GROUP BY vec_id
            ), good AS (
                SELECT vec_id, e FROM v
                WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
            ), link AS (
                SELECT a.vec_id AS u, b.vec_id AS w FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
                WHERE list_cosine_similarity(a.e, b.e) >= 0.9
            ), reach AS (
                SELECT vec_id AS u, vec_id AS w FROM v
                UNION
                SELECT r.u, l.w FROM reach r JOIN link l ON r.w = l.u
            )
            SELECT v.vec_id, (SELECT count(*) FROM link l WHERE l.u = v.vec_id) AS n_links, r.c AS component_id, r.c = v.vec_id AS kept
            FROM v JOIN (SELECT u, min(w) AS c FROM reach GROUP BY u) r ON r.u = v.vec_id""",
    }
