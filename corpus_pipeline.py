"""A corpus pipeline of five stages over the documents table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from learnmill.llm import bpe, decontaminate, linededup, simhash, toxicity
from learnmill.llm.common import scratch_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned lexicon calls toxic go; all others stay as they are, rows with a null id or text among them. Repeated rows are judged alike, and
    without labels of both kinds, or documents, nothing goes."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are near an earlier line are cut; n_chars follows the text. No document goes, and no other column changes. Null texts stay null (and n_chars
    too), rows with a null id lose only lines that they repeat themselves, rows that repeat an id count as one document."""
    return linededup.cut_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (fingerprints within 3 bits, or Jaccard 0.8 of five-word shingles) stays, the one with the smallest doc_id. Null and
    empty texts are one group; rows with a null id stay."""
    return simhash.keep_one_similar(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage near a benchmark item go. Rows with a null id or text stay, as does all without items; rows that repeat an id go together."""
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and what they decode to, as counts and digests, one row for each row. Null and empty texts have no tokens."""
    return bpe.digests(bpe.encode_decode(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("BPE encoding and decoding", encode),
]

#: Learned scores, MinHash and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents, each result written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    base = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
