"""The opN_ queries over the driver's tables: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsql.llm import html_text, jaccard_join, line_dedup, oracles, packing, pii, quality, sentencepieces, topk_search, url_filters, warc
from quillsql.llm.common import cut_lineage, table


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that earlier ones have."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_kept_lines", "text")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives, then read back."""
    bundles = cut_lineage(warc.write_bundles(warc.mark_revisits(table(spark, sf_dir, "pages"))))
    return warc.read_bundles(bundles, payloads=False).drop("payload")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class and number of links of every document, at five words and 0.8."""
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by rule, else by the regression."""
    judged = url_filters.judge_urls(table(spark, sf_dir, "pages"), url_filters.default_model(spark))
    return judged.select(
        "page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"), F.col("url_rule").alias("rule"),
        F.col("url_verdict").alias("verdict"), F.round("url_score", 6).alias("score"),
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures and verdict of every document."""
    measured = quality.quality(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
    return measured.select("doc_id", *(name for name, _ in quality.METRICS))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = html_text.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.col("main_chars").alias("n_chars"))


def _of_kind(kind: int) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and spans of personal data of every document."""
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii_spans", lambda s: s["base"])
    counts = [F.size(F.filter(base, _of_kind(k))) for k in range(pii.BASE_KINDS)]
    return found.select(
        "doc_id",
        *(c.cast("long").alias(f"n_{pii.KINDS[k]}") for k, c in enumerate(counts)),
        F.sha2(F.encode(pii.span_list(base), "UTF-8"), 256).alias("base_sha256"),
        pii.span_list(F.col("pii_spans")).alias("spans"),
    )


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document's whole text."""
    return sentencepieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("piece_bpe_32k.model"))


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 20 is a query against all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    asked = docs.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    return topk_search.search(asked, docs).withColumn("score", F.round("score", 6))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_line_dedup": op2_line_dedup,
        "op3_warc": op3_warc,
        "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
        "op5_url_filters": op5_url_filters,
        "op6_quality_rules": op6_quality_rules,
        "op7_html_extraction": op7_html_extraction,
        "op8_pii": op8_pii,
        "op9_sentencepiece": op9_sentencepiece,
        "op10_topk_search": op10_topk_search,
    }


def oracle_sql() -> dict[str, str]:
    """The queries whose whole result SQL can state; tests hold the others to brute force or to the libraries."""
    return dict(oracles.ORACLES)
