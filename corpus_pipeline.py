"""Corpus cleaning pipeline over ``documents``.

Five stages, each one operator of ``sismo.llm``: quality rules, near
duplicates, benchmark decontamination, personal data, packing. Every stage
works on all documents its predecessor kept; its result is written as Parquet
to the shared scratch folder and read again as the next one's input. All but
the last return the columns of ``documents``.

Null texts are empty to every stage (the first rejects them); an empty table
passes through as one; extra columns pass through all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sismo.llm.decontam import drop_contaminated
from sismo.llm.ngram_join import keep_one
from sismo.llm.packing import pack_documents
from sismo.llm.pii import mask_pii
from sismo.llm.quality import keep_good
from sismo.session import Scratch

TOKENIZER = "word_bpe_49k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), short_items=True)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by marks, n_chars renewed."""
    return mask_pii(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place."""
    return pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("pii", personal_data),
    ("best_fit_packing", packing),
]

#: None of the stages but the word rules can be written in SQL; the tests hold
#: the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    s = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, s.keep(stage(spark, docs, sf_dir), name)
        s.drop(before)
    return docs
