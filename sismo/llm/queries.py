"""Registered queries of the training-data operators: thin wrappers that run
each operator with its production parameters over the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_skip_chain_pii(spark, sf_dir):
    from .pii import find_pii
    return find_pii(table(spark, sf_dir, "documents"))


@query
def op2_benchmark_decontamination(spark, sf_dir):
    from .decontam import find_contamination
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short_items=True)


@query
def op3_license_scan(spark, sf_dir):
    from .license_scan import license_scan
    return license_scan(table(spark, sf_dir, "documents"))


@query
def op4_best_fit_packing(spark, sf_dir):
    import public_tokenizers
    from .packing import pack_documents
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op5_token_id_files(spark, sf_dir):
    import public_tokenizers
    from .huffman import token_id_files
    return token_id_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op6_ngram_jaccard_join(spark, sf_dir):
    from .ngram_join import ngram_join
    return ngram_join(table(spark, sf_dir, "documents"))


@query
def op7_quality_rules(spark, sf_dir):
    from .quality import quality_rules
    return quality_rules(table(spark, sf_dir, "documents"))


@query
def op8_language_id(spark, sf_dir):
    from .langid import identify_language
    return identify_language(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "rejected")


@query
def op9_html_main_text(spark, sf_dir):
    from .html_text import extract_text
    return extract_text(table(spark, sf_dir, "pages"))


@query
def op10_sentence_span_dedup(spark, sf_dir):
    from .sentence_spans import dedup_sentence_spans
    return dedup_sentence_spans(table(spark, sf_dir, "documents"))


@query
def op11_secret_scan(spark, sf_dir):
    from .secret_scan import find_secrets
    return find_secrets(table(spark, sf_dir, "documents"))


@query
def op12_source_divergence(spark, sf_dir):
    from .divergence import source_divergence
    return source_divergence(table(spark, sf_dir, "documents"))


@query
def op13_spelling_variants(spark, sf_dir):
    from .spelling import spelling_variants
    return spelling_variants(table(spark, sf_dir, "documents"))


@query
def pipeline(spark, sf_dir):
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import divergence, license_scan, spelling
    return {**ORACLES, "op3_license_scan": license_scan.oracle(), "op12_source_divergence": divergence.oracle(),
            "op13_spelling_variants": spelling.oracle()}
