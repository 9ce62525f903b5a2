"""The corpus pipeline: quality rules, near duplicates, benchmark decontamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows the stage before it kept; all but the last return the
columns of documents. Rejected documents go, one document of each class of near duplicates stays, contaminated
documents go, secrets are replaced by a mark, and what is left is encoded: doc_id, n_tokens, ids, and digests of the
ids and of the decoded text.

Null and empty texts have no words and so fail the quality rules; very long texts are taken whole. Rows with a null
doc_id are judged by the rules, kept by the stages that judge by doc_id, and encoded. Of repeated rows, and of rows of
one doc_id with different texts, one stays. A null source is a host of its own. Further columns travel along up to the
last stage, whatever their names. An empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cloudloom.llm import bpe, decontaminate, neardup, quality, secrets
from cloudloom.llm.common import staged, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, with_decoded=False)


STAGES = [
    ("quality rules", good_documents),
    ("MinHash near-dedup", one_of_each),
    ("benchmark decontamination", uncontaminated),
    ("secret scans", without_secrets),
    ("BPE encoding and decoding", encoded),
]
#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, f"stage-{k + 1}")
    return docs
