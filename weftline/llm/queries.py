"""The registered queries of the training-data operators, over whole tables with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, merkle_text, mixing, pii, preference, resample, simhash, spans, toxicity, warc
from .common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = table(spark, sf_dir, "conversations")
    return preference.digest(preference.preferences(chosen, preference.shortened(chosen)))


def op3_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_text.edit_fingerprints(table(spark, sf_dir, "documents"))


def op4_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.digest(spans.repeated(table(spark, sf_dir, "documents")))


def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, _, _ = resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))[0]


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.spans(table(spark, sf_dir, "documents")))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op10_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return warc.fixity(pages, warc.damaged(pages))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_preference, op3_merkle_fingerprints, op4_sentence_spans, op5_importance_resampling, op6_toxicity, op7_mixing, op8_pii, op9_simhash, op10_warc_fixity, pipeline)}
ORACLES = {"op2_preference": preference.ORACLE, "op7_mixing": mixing.ORACLE, "op10_warc_fixity": warc.ORACLE}
