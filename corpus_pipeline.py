"""The corpus pipeline: five stages over documents, each one operator of thalweg.llm.

Every stage takes what its predecessor kept and its decisions take effect: texts scored toxic go; of each group of near
copies the row of the smallest id stays; secrets are replaced within the texts, of which none goes; sources are mixed
to their target weights, rows as often as the mix takes them; what remains is cut into packed pieces. Null and empty
texts pass the first three stages; a table without rows passes all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.llm import common, mixing, packing, secrets, simhash, toxicity

MARK = "[secret]"


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, toxicity.train(docs, common.table(spark, sf_dir, "labels")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs, MARK)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.digest_of_pieces(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_copies),
    ("secrets", without_secrets),
    ("mixing", mixed_sources),
    ("packing", packed),
]

#: No stage can be said in SQL: a fitted classifier comes first.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
