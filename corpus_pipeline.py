"""Five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; the last returns the
pieces of packed sequences, the others the columns of documents. Stages that decide on rows name each by a hash of its id and
text, so rows with a null or a repeated id are decided by their own text. Equal rows with words are copies of each other, of which
one stays.
"""

from __future__ import annotations

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import decontaminate, ngram_jaccard, packing, quality, secrets
from pagewright.llm.common import keep


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the best grade is 0.5 or more."""
    labels = quality.grades_of(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.kept(docs, quality.train(docs, labels))


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents with a hash of id and text as ``_row``; a column of that name comes back by ``_own``."""
    return docs.toDF(*(f"{c}_" if c.startswith("_row") else c for c in docs.columns)).withColumn("_row", F.xxhash64("doc_id", "text"))


def _own(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.drop("_row").toDF(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates (five words, Jaccard 0.8) the document with the smallest id, null ids last."""
    rows = _keyed(docs)
    found = ngram_jaccard.jaccard_components(rows.select("_row", "text"), id_col="_row", size=5, percent=80)
    named = found.where("n_shingles > 0").groupBy("_row", "component_id").agg(F.count("*").alias("n"))
    named = named.join(rows.select("_row", "doc_id").distinct(), "_row")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    first = named.groupBy("component_id").agg(F.min(place)["_row"].alias("first"))
    placed = keep(named.join(first, "component_id").select("_row", (F.col("_row") != F.col("first")).alias("gone"), F.col("n")), "placed")
    kept = rows.join(placed.where("gone").select("_row"), "_row", "left_anti")
    repeated = keep(placed.where("not gone and n > 1").select("_row"), "repeated")
    if repeated.isEmpty():
        return _own(kept, docs)
    once = kept.join(repeated, "_row", "left_semi").dropDuplicates(["_row"])
    return _own(kept.join(repeated, "_row", "left_anti").unionByName(once), docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (five words, containment 0.8)."""
    rows = _keyed(docs)
    found = decontaminate.leaks(rows.select("_row", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="_row")
    gone = keep(found.select("_row").distinct(), "leaked")
    return _own(rows.join(gone, "_row", "left_anti"), docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret replaced by a mask; n_chars follows the text."""
    ledger = secrets.update_ledger(docs.select("doc_id", "text"))
    spans = "_spans"
    while spans in docs.columns:
        spans += "_"
    found = secrets.findings(docs, ledger, docs.columns, spans=spans)
    out = found.withColumn("text", secrets.redacted(F.col("text"), F.col(spans)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.drop(spans)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: The classifier, the tokenizer and the packing can't be said in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = keep(docs, f"stage-{name}")
    return docs
