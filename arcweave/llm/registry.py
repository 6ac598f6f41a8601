"""The queries of this subpackage and the SQL that says the same, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arcweave.llm import chat, decontaminate, fingerprint, langid, license, lm, pii, sentencepiece, simhash, toxicity
from arcweave.llm.common import table


def op1_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode(table(spark, sf_dir, "documents"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), matched=True)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace(docs)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.predict(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = chat.with_control(spark, table(spark, sf_dir, "conversations"))
    return chat.read_back(chat.format_conversations(chat.linear_trees(conversations)))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # at the repository's top, not in the package

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license": op1_license,
    "op2_simhash": op2_simhash,
    "op3_fingerprint": op3_fingerprint,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_langid": op5_langid,
    "op6_lm": op6_lm,
    "op7_pii": op7_pii,
    "op8_toxicity": op8_toxicity,
    "op9_chat": op9_chat,
    "op10_decontaminate": op10_decontaminate,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    "op3_fingerprint": fingerprint.ORACLE,
    "op9_chat": chat.ORACLE,
    "op10_decontaminate": decontaminate.ORACLE,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
