"""The queries p6 to p8 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.bpe import encode_corpus
from tideline.llm.leakage import leaked, without_leaks
from tideline.llm.residue import residue_documents, residue_messages, without_residue
from tideline.session import table


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"))


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    """With the length of the longest verbatim match, of the stretch, and its edits."""
    return leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).select("doc_id", "item_id")


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return without_leaks(docs, leaked(docs, table(spark, d, "eval_items"))).select("doc_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return residue_documents(table(spark, d, "documents")).select("doc_id")


def p8_messages(spark: SparkSession, d: str) -> DataFrame:
    """The recurring messages, with how many documents and sources hold them, and their class."""
    _, distinct = residue_messages(table(spark, d, "documents"))
    return distinct.where("n_sources > 1 and class <> 'content'").select("message", "class", F.col("n_rows").alias("n_documents"), F.col("n_sources"))


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return without_residue(docs, residue_documents(docs)).select("doc_id")


QUERIES = {f.__name__: f for f in (p6_ids, p7_found, p7_leaks, p7_clean, p8_found, p8_messages, p8_clean)}
#: None of the three can be said in SQL; tests compare with the reference tokenizer, brute force and hand-made cases.
SQL: dict[str, str] = {}
