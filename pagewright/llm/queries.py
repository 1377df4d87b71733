"""The opN queries over the driver's tables, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import chat, decontaminate, embedding_dedup, licenses, ngram_jaccard, packing, quality, secrets, tokens, urls
from pagewright.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page; rules are mined from pages whose label is toxic or of low quality."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    rated = labels.groupBy("doc_id").agg(F.max((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("blocked"))
    labelled = pages.join(rated, F.col("page_id") == F.col("doc_id")).select("url", "blocked")
    return urls.judge(pages, urls.mined_rules(labelled))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, tail probabilities and decision for every document."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, quality.grades_of(table(spark, sf_dir, "labels")))
    scored = quality.score(docs, model, columns=["doc_id"])
    return scored.select(
        "doc_id", "expected_grade", F.get("p_at_least", F.lit(0)).alias("p_not_toxic"), F.get("p_at_least", F.lit(1)).alias("p_good"), F.col("keep").alias("kept")
    )


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of every document."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors of equal label at a cosine of 0.93 or more."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and the benchmark items that it holds."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user message as a call and the message after it as its result, with calls that messages hold, results without a call, and other messages."""
    messages = table(spark, sf_dir, "conversations")
    schemas = spark.createDataFrame(
        [("reply", "turn", "integer", True), ("reply", "text", "string", True), ("reply", "after", "object", False)],
        "name string, argument string, kind string, required boolean",
    )
    calls = chat.exchange_calls(messages).unionByName(chat.embedded_calls(messages))
    results = chat.exchange_results(messages).unionByName(chat.embedded_results(messages))
    rows = chat.conversation_rows(messages, calls, results, schemas, roles=("user", "assistant", "tool"))
    return rows.withColumn("errors", F.array_join("errors", ","))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, by a ledger that starts empty."""
    docs = table(spark, sf_dir, "documents")
    found = secrets.findings(docs, secrets.update_ledger(docs), ["doc_id"])
    spans, base = F.col("found_spans"), [r.kind for r in secrets.BASE_RULES]
    counts = [F.size(secrets.of_kind(spans, kind)).cast("long").alias(f"n_{kind}") for kind in base]
    digest = F.sha2(secrets.joined(secrets.of_kind(spans, *base)).cast("binary"), 256)
    return found.select("doc_id", *counts, digest.alias("base_sha256"), secrets.joined(spans).alias("spans"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets have a Jaccard similarity of 0.85 or more."""
    return ngram_jaccard.jaccard_components(table(spark, sf_dir, "documents"), size=4, percent=85)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram of encoded lengths with totals for every context limit."""
    histogram = tokens.length_histogram(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return tokens.context_limits(histogram)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), window=2048, end_id=1)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filters,
        op2_quality_classifier,
        op3_license_scans,
        op4_embedding_near_dedup,
        op5_benchmark_decontamination,
        op6_chat_formatting,
        op7_secret_scans,
        op8_ngram_jaccard,
        op9_token_counts,
        op10_packing,
    )
}
