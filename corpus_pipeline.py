"""A corpus from documents to shards: language ID, near-dedup, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written and read again as the docs of the
next one. All but the last return the columns of documents. Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorewell.llm.bagminhash import one_of_each
from lorewell.llm.common import keep, stash, unstash
from lorewell.llm.decontamination import without_leaks
from lorewell.llm.langid import keep_identified
from lorewell.llm.mixing import mixed_documents
from lorewell.llm.resharding import shard_documents
from lorewell.session import table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without a letter, or of no clear language, go (operator 10)."""
    return keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that of the least doc_id (operator 7)."""
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item (operator 4)."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights takes them (operator 5)."""
    return mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The new shard and slot of every document (operator 6)."""
    return shard_documents(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix_sources", mix_sources), ("shard", shard)]

#: SQL has no form of the learned and approximate stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs, path = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        done, written = stash(stage(spark, docs, sf_dir))
        if path:
            unstash(spark, path)
        docs, path = done, written
    out = keep(STAGES[-1][1](spark, docs, sf_dir))
    if path:
        unstash(spark, path)
    return out
