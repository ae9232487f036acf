"""The corpus pipeline: toxic documents go, one of each group of near copies stays, secrets are blacked out, sources are mixed to
their target weights, and what is left is encoded.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Between two stages
the documents are written as Parquet and read again, so a stage's lost executors cost that stage's work only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from otreelake.llm import bpe, mixing, neardup, secret_scan, toxicity
from otreelake.llm.common import shared_dir, table
from otreelake.llm.queries import VOCABULARY


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the ordinal model finds toxic. Null and empty texts have no evidence and stay; repeated rows are judged alike; without labels nothing goes."""
    return toxicity.drop_toxic(docs, toxicity.fit_on(docs, table(spark, sf_dir, "labels")))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of every group of near copies (five words, similarity 0.8). Texts without words and rows without an id are in no group and stay; rows of one id stay or go together."""
    return neardup.keep_one(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts [SECRET] in the place of every secret, and brings n_chars up to date. Null texts stay null; no row goes."""
    return secret_scan.redact_secrets(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in its order. Null is a source of its own; a document without words comes once; repeated rows are documents of their own."""
    return mixing.mixed_documents(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every document. Null and empty texts have no tokens."""
    encoded = bpe.bpe_encode(docs, VOCABULARY)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", toxicity_stage), ("minhash_near_dedup", neardup_stage), ("secret_scans", secrets_stage), ("mixing", mixing_stage), ("bpe", bpe_stage)]

#: The classifier and the signatures have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What lies between them is in the shared folder: a stage's input goes when its output is written, but
    for the last one's, which the result still reads.

    An empty table gives no rows. Null ids, repeated rows and columns of any names pass through all stages but the last, which returns ids, token counts and tokens."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    read = None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            if read:
                remove(spark, read)
            read = f"{folder}/{k}-{name}"
            docs = spark.read.parquet(read)
    return docs
