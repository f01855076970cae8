"""From raw documents to token ids: quality rules, near-duplicate removal, repeated passages, benchmark leaks, tokens.

Each stage is a function of (spark, docs, sf_dir) on what its predecessor kept; ``run`` writes each
stage's rows as Parquet and reads them again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import bpe, common, decontam, jaccard, quality, suffix_dedup


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go: few words, repeated words, low quality, toxic."""
    return quality.keep(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links of 5-word shingle similarity 0.8 tie together, the smallest doc_id stays."""
    return jaccard.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 100-byte strings that occur earlier go; every document stays with what is left."""
    return suffix_dedup.deduplicated(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, re-parameterised or not, go."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source (where docs have them), the token ids and their number."""
    about = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    encoded = bpe.encode(docs.select(*about, "text"), bpe.default_path())
    return encoded.select(*about, F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("BPE encoding", tokens),
]

#: SQL cannot express the stages; they are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
