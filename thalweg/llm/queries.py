"""The registered query of each operator, with its production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, documents, table
from .licenses import oracle_sql as licenses_sql
from .search import oracle_sql as search_sql


def op1_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: the whole texts of the documents whose id is divisible by 20, against all documents."""
    from . import search

    docs = documents(spark, sf_dir)
    return search.search(docs, docs.where("doc_id % 20 = 0"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "source", "size", "source_size", "target", "taken")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = documents(spark, sf_dir)
    weights = toxicity.train(docs, table(spark, sf_dir, "labels"), fold=(3, 1))
    return _decided(toxicity.score(docs, weights), 3, 1)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import licenses

    return licenses.scan(documents(spark, sf_dir))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import weighted_sampling

    return weighted_sampling.fingerprints(documents(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import packing

    return packing.digest_of_pieces(packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    return _decided(quality.classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"), "quality", fold=(4, 2)), 4, 2)


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language_model

    docs = documents(spark, sf_dir)
    held_out = crc_mod("doc_id", 7) == 2
    scores = language_model.score(docs, language_model.train(docs, ~held_out))
    return scores.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets

    return secrets.scan(documents(spark, sf_dir)).select("doc_id", "n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans")


def _decided(scores: DataFrame, modulus: int, held_out: int) -> DataFrame:
    return scores.select("doc_id", (crc_mod("doc_id", modulus) == held_out).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_search": op1_search,
    "op2_mixing": op2_mixing,
    "op3_toxicity": op3_toxicity,
    "op4_simhash": op4_simhash,
    "op5_licenses": op5_licenses,
    "op6_fingerprints": op6_fingerprints,
    "op7_packing": op7_packing,
    "op8_quality": op8_quality,
    "op9_language_model": op9_language_model,
    "op10_secrets": op10_secrets,
}

ORACLE_SQL: dict[str, str] = {"op1_search": search_sql(), "op5_licenses": licenses_sql()}
