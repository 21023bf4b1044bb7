"""The operators over the standard tables: ``opN_<name>`` and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import embeddings, licenses, mixing, packing, quality, sharding, simhash, tokens, toxicity, warc

#: Vocabulary of op1; a file of the public_tokenizers package.
VOCABULARY = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.encode_and_digest(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # shards of about 1.5 MB of text, so that the tree splits on tables of a few megabytes too
    return mixing.taken(table(spark, sf_dir, "documents"), block_words=1 << 13, shard_words=1 << 17)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), near=True)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.query(table(spark, sf_dir, "pages"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), sharding.QUERY_LIMIT)


def queries() -> dict:
    return {f.__name__: f for f in (op1_token_ids, op2_mixing, op3_simhash_near_dedup, op4_best_fit_packing, op5_quality_rules, op6_toxicity, op7_warc_revisits, op8_license_scan, op9_embedding_near_dedup, op10_sharding)}


def oracle_sql() -> dict[str, str]:
    return {"op5_quality_rules": quality.ORACLE_SQL, "op7_warc_revisits": warc.ORACLE_SQL, "op9_embedding_near_dedup": embeddings.ORACLE_SQL, "op10_sharding": sharding.ORACLE_SQL}
