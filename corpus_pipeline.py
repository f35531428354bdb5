"""Corpus preparation: five stages, each of which works on what its predecessor kept.

A stage's result is written before the next stage begins: a stage then deletes the tables that the stage before
it wrote to the shared folder on its way.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import common, decontaminate, jaccard_join, pieces, secrets, toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_spent: list[tuple[int, int]] = []


def _stage(f: Stage) -> Stage:
    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _spent:
            common.clear(*_spent.pop())
        start = common.mark()
        out = f(spark, docs, sf_dir)
        _spent.append((start, common.mark()))
        return out

    return run


@_stage
def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go. Null and empty texts score as no words; repeated rows are judged each; an empty table stays empty."""
    return toxicity.clean(docs, common.table(spark, sf_dir, "labels"))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays.

    Null and empty texts link with nothing and stay; of rows with one id one stays, the smallest text; rows with a null id all stay.
    """
    return jaccard_join.deduplicated(docs)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with 1 in 20 words or more inside benchmark passages go. Null and empty texts stay; repeated rows go or stay together."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


@_stage
def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; n_chars follows the text. Null texts stay null and keep their n_chars."""
    found = secrets.redacted(docs)
    return found.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


@_stage
def tokenization(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids and number: none for null and empty texts; repeated rows each have theirs."""
    return pieces.encode(docs).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_redaction),
    ("SentencePiece encoding", tokenization),
]

#: Toxicity and tokenization are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        docs = common.save(out, name.replace(" ", "-").lower())
    return docs
