"""Corpus pipeline: documents to a token store, five stages, each over all its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet in
the job's shared folder and read again as the next stage's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyring.llm import contamination, jaccard, mixing, scratch, store, toxicity
from tallyring.llm.queries import BPE
from tallyring.ship import ship


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the classifier learns as in op2."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    third = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(3))
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels, third != 1))


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the Jaccard join, the one with the smallest id."""
    ship(spark)
    return jaccard.keep_one(docs)


def contaminated_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth stand in benchmark windows."""
    ship(spark)
    return contamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.resample(docs, lambda df: scratch.table(df, "mix"))


def stored(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token store of what is left, read back."""
    ship(spark)
    path = scratch.folder(spark, "store")
    store.write(docs, path, BPE)
    store.manifest(spark, path)
    return store.read_back(spark, path)


STAGES = [
    ("toxicity", toxic_out),
    ("ngram_jaccard_join", near_copies_out),
    ("benchmark_decontamination", contaminated_out),
    ("source_mixing", mixed),
    ("token_store", stored),
]

#: The classifier's and the tokenizer's results are not for SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, scratch.table(stage(spark, docs, sf_dir), f"stage-{name}")
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
