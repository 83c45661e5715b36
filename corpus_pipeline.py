"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one
before it has kept; all but the last return the columns of documents.

* quality: documents that the classifier rejects go.
* near_duplicates: of each group of near duplicates (five words, similarity 0.8) one stays.
* decontamination: documents that hold a test item of the benchmark go.
* secrets: every span found is replaced by a mark; the documents stay.
* packing: pieces of token sequences.

Nulls, empty texts, repeated rows and empty tables are handled as each operator's
module says; columns beyond those of documents are carried through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontamination, near_dedup, packing, quality_classifier, secrets
from lectern.llm.common import keep, sheltered


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    inside, restore = sheltered(docs, "doc_id", "text")
    return restore(quality_classifier.score(inside, labels).where("predicted = 1"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.first_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    inside, restore = sheltered(docs, "doc_id", "text")
    return restore(decontamination.find_leaks(inside, benchmark).where("not contaminated"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("secrets", redact),
    ("packing", pack),
]

#: The stages learn a model, hash and tokenise: SQL cannot express them; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs
