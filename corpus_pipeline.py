"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns
of documents; the last returns the encoded documents.

Defined results: a null text counts as empty and stays null; empty texts are copies
of one another, so one of them stays; repeated rows are copies, so one stays; nulls
in other columns and columns of other names pass through; an empty table gives an
empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terravox.llm import bpe_chunks, decontaminate, jaccard_join, secret_scan, toxicity
from terravox.llm.common import scratch_path, table
from terravox.llm.queries import tokenizer_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.7 stay."""
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of copies and near copies the document with the least id stays."""
    return jaccard_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; their secrets are replaced by the name of their kind."""
    return secret_scan.redact_secrets(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids of every document."""
    import public_tokenizers

    return bpe_chunks.bpe_encode(docs, tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", one_of_near_copies), ("benchmark_decontamination", drop_contaminated), ("secret_scans", redact), ("byte_level_bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is a Parquet table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Compressed lengths, chosen paths and byte-pair merges have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None
