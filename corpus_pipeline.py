"""A corpus pipeline of five stages: each is written as Parquet and read again as the next one's docs."""

from __future__ import annotations

import tempfile  # noqa: F401  tests use it by this name
import uuid

from pyspark.sql import DataFrame, SparkSession

from arcweave.llm import decontaminate, pii, sentencepiece, simhash, toxicity
from arcweave.llm.common import drop_folder, shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't reject. It learns from the labels of this stage's documents."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, each row judged by itself; see ``simhash.keep_one``."""
    return simhash.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the benchmark's passages; those of nothing else go."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data and secrets, keyed by the session's ``spark.arcweave.pii.key``."""
    return pii.replace(docs, key=spark.conf.get("spark.arcweave.pii.key", pii.KEY), kinds=None)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, with the digest of the text decoded from them."""
    return sentencepiece.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", remove_benchmark),
    ("pii", replace_pii),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, in the shared folder that spark.checkpoint.dir names.

    Each stage's table goes when the next one's is written; the last stays, as it is the result.
    """
    place = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{place}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            drop_folder(spark, before)
        before = path
    return docs


#: Trained models, fingerprints and keyed surrogates are beyond SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None
