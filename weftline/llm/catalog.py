"""Queries of this subpackage by name; SQL oracles where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.keys import norm_key
from weftline.llm.consensus import Consensus, consensus
from weftline.llm.packing import fill_rates, pack
from weftline.llm.pairs import describe_pairs, find_defects
from weftline.llm.pii import find_personal, replace_personal
from weftline.llm.secrets import find_credentials, redact_credentials
from weftline.llm.tokens import count_tokens, decode_ids, encode_texts
from weftline.sources.tables import table

#: The labels of problem 3, in the order that decides between equal posteriors.
VERDICTS = ["EXPLOITABLE", "NOT_EXPLOITABLE", "UNCERTAIN"]
LEAST_VOTERS = 5


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 1: defective instruction-response pairs with the type of the defect."""
    return find_defects(table(spark, sf_dir, "tool_use_training"))


def p1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 1: every pair with its defect, copied share and languages."""
    return describe_pairs(table(spark, sf_dir, "tool_use_training"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 2: lines on which credentials begin."""
    return find_credentials(table(spark, sf_dir, "code_findings"))


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 2: every code text with its credentials replaced."""
    return redact_credentials(table(spark, sf_dir, "code_findings"))


def _consensus(spark: SparkSession, sf_dir: str) -> Consensus:
    bare = F.regexp_replace(F.lower(F.col("verdict")), r"[\s_.\-/\u00a0\u2010-\u2015]+", "")
    label = F.when(bare == "exploitable", VERDICTS[0]).when(bare == "notexploitable", VERDICTS[1]).when(bare == "uncertain", VERDICTS[2])
    member = F.regexp_replace(F.lower(F.col("member")), r"[\s_.\-/\u00a0\u2010-\u2015]+", "")
    opinions = table(spark, sf_dir, "member_opinions").select(
        norm_key("finding").alias("item"), F.when(member != "", member).alias("annotator"), label.alias("label"), F.col("opined_at").alias("at"), F.struct("ingested_at", "opinion_id").alias("tie")
    )
    return consensus(opinions, VERDICTS)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 3: consensus verdict of findings with at least five voters."""
    return _consensus(spark, sf_dir).items.where(F.col("voters") >= LEAST_VOTERS).select(F.col("item").alias("finding"), F.col("label").alias("verdict"))


def p3_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 3: consensus, posterior, agreement and voters of every finding."""
    return _consensus(spark, sf_dir).items.withColumnRenamed("item", "finding").withColumnRenamed("label", "verdict")


def p3_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 3: reliability, type and number of opinions of every member."""
    return _consensus(spark, sf_dir).annotators.withColumnRenamed("annotator", "member")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 7: token ids of every document."""
    return encode_texts(table(spark, sf_dir, "documents"))


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 7: every document encoded and decoded again."""
    return decode_ids(encode_texts(table(spark, sf_dir, "documents")))


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 8: the container of every part of every document, for each capacity."""
    return pack(count_tokens(table(spark, sf_dir, "documents")), table(spark, sf_dir, "container_sizes"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 8: number of containers and share of their space that is used, for each capacity."""
    return fill_rates(p8_packed(spark, sf_dir), table(spark, sf_dir, "container_sizes"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 9: lines on which personal information begins, by type."""
    return find_personal(table(spark, sf_dir, "documents"))


def p9_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 9: every document with typed placeholders, and with surrogates."""
    return replace_personal(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_pairs, p2_found, p2_redacted, p3_found, p3_items, p3_members, p7_ids, p7_decoded, p8_packed, p8_fill, p9_found, p9_replaced)}

SQL = {
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
