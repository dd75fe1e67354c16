"""Queries p7 to p9: operators on the texts of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortloom.llm import leakage, pii, tokens
from cohortloom.session import table


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"))


def p8_stretches(spark: SparkSession, d: str) -> DataFrame:
    """Each document with the items that leaked into it, and how much of each."""
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_stretches(spark, d).select("doc_id", "item_id")


#: The setting that holds the key of the pseudonyms, and what stands in where there is none: then they can be undone by anyone.
SECRET, OPEN_SECRET = "spark.cohortloom.pseudonym.key", "no key was set"


def p9_places(spark: SparkSession, d: str) -> DataFrame:
    """Every place, where it ends and the pseudonym that stands for it."""
    return pii.find_pii(table(spark, d, "documents"), pii.lexicon_of(table(spark, d, "users")), spark.conf.get(SECRET, OPEN_SECRET))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_places(spark, d).select("doc_id", "pii_type", "start_pos")


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact_pii(table(spark, d, "documents"), pii.lexicon_of(table(spark, d, "users")), spark.conf.get(SECRET, OPEN_SECRET))


QUERIES = {f.__name__: f for f in (p7_ids, p8_found, p8_stretches, p9_found, p9_places, p9_redacted)}
#: SQL can express none of them.
ORACLES: dict[str, str] = {}
