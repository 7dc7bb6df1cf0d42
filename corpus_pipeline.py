"""The corpus pipeline: documents to packed training sequences, each stage one of the operators in quillsql.llm.

Every stage but the last returns the columns of documents and takes any columns beside them. Null texts count as empty,
null ids are allowed, an empty table stays empty, and texts of any length are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsql.llm import jaccard_join, line_dedup, packing, pii, quality
from quillsql.llm.common import cut_lineage, table
from quillsql.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep: a null or empty text goes; repeated rows stay or go together; no column is renamed."""
    measured = quality.quality(docs, vocabulary("piece_bpe_32k.model"))
    return measured.where("kept").select(docs.columns)


def line_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that earlier ones have; a document of nothing else, or without words, goes.

    Earlier is by doc_id, null ids first, then a hash of the text. Rows that repeat an id and a text keep the same lines.
    """
    cut = line_dedup.dedup_lines(docs).where(F.col("text").rlike(r"[^ \t\n\x0B\f\r]"))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near copies, null ids being the greatest; of repeated rows one stays.

    Texts without words are nobody's copies.
    """
    return jaccard_join.first_of_each_class(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked by its kind; none goes, a null text stays as the operator leaves it."""
    found = pii.find_pii(docs)
    text = F.when(F.size("pii_spans") > 0, pii.masked(F.col("text"), F.col("pii_spans"))).otherwise(F.col("text"))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens: a null text has one token, repeated rows are packed each."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_copies),
    ("ngram_jaccard_join", near_copies),
    ("pii", personal_data),
    ("best_fit_packing", packed),
]

#: Tokenizers and trained models have no SQL form; tests hold run() to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
