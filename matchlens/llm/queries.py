"""Registered queries of the subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlens.llm import langid, linededup, media, mixing, packing, partenum, permutation, quality, setsketch, token_output, variants, warc, whitening
from matchlens.llm.common import table
from matchlens.llm.oracle import ORACLE_SQL


def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return permutation.search(vectors, vectors.where("vec_id % 20 = 0"), 20)


def op2_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.deduped(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op3_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op4_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.jaccard_components(table(spark, sf_dir, "documents"), width=3, percent=90)


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_interleaved_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.document_media(table(spark, sf_dir, "documents"))


def op7_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op8_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_rows(warc.transactions(table(spark, sf_dir, "pages")))


def op9_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.simple8b(spark, table(spark, sf_dir, "documents"))


def op10_output_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(table(spark, sf_dir, "documents"))


def op11_fm_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_forms(table(spark, sf_dir, "documents"))


def op12_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op13_spectrum_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


__all__ = ["ORACLE_SQL", "REGISTRY"]

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_permutation_index, op2_line_templates, op3_pivotal_mix, op4_partenum_join, op5_kneser_ney, op6_interleaved_media,
                            op7_cost_packing, op8_warc_transactions, op9_simple8b, op10_output_codes,
                            op11_fm_variants, op12_setsketch, op13_spectrum_whitening, pipeline)}
