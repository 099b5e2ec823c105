"""Queries of the training-data operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import written
from . import bpe, langid, line_dedup, media, neardup, packing, quality, sharding, simhash, token_counts


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(modulus: int):
    """crc32 of the id as text, modulo."""
    return F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(modulus))


def op1_bpe(spark, sf_dir):
    return bpe.round_trip(_documents(spark, sf_dir), tokenizer_path())


def op2_quality(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), remainder(3) != 1)
    return quality.score(docs, model).select("doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_packing(spark, sf_dir):
    return packing.pack(_documents(spark, sf_dir), tokenizer_path())


def op4_token_counts(spark, sf_dir):
    return token_counts.token_counts(_documents(spark, sf_dir), tokenizer_path())


def op5_line_dedup(spark, sf_dir):
    docs = _documents(spark, sf_dir).select("doc_id", "text", F.length("text").alias("n_chars"))
    out = line_dedup.dedup(docs)
    return out.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.length("text").cast("long").alias("kept_chars"), F.col("_chunks").cast("long").alias("kept_chunks"), F.sha2("text", 256).alias("kept_sha256"))


def op6_simhash(spark, sf_dir):
    rows = written(simhash.near_edits(_documents(spark, sf_dir)))  # small rows, read by the search and for the result
    return simhash.with_neighbours(rows, F.col("doc_id") % 100 == 0).drop("fp")


def op7_matroska(spark, sf_dir):
    return media.round_trip(_documents(spark, sf_dir))


def op8_jump_sharding(spark, sf_dir):
    return sharding.shard(_documents(spark, sf_dir), 16)


def op9_minhash(spark, sf_dir):
    return neardup.near_duplicates(_documents(spark, sf_dir))


def op10_language(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    net = langid.fit(docs, remainder(4) != 2)
    return langid.predict(docs, net).select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")


def queries():
    return {f.__name__: f for f in (op1_bpe, op2_quality, op3_packing, op4_token_counts, op5_line_dedup, op6_simhash, op7_matroska, op8_jump_sharding, op9_minhash, op10_language)}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return ORACLES
