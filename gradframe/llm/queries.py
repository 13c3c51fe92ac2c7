"""The numbered corpus operators as queries over the test tables, with SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gradframe.llm import (
    conversations, extraction, factorisation, fixity, imatch, jaccard, licences, mixing, packing, periods, personal, rules,
    topk,
)
from gradframe.llm.columns import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


@_query("op1_factorisation_machine")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return factorisation.classified(documents(spark, sf_dir), labels)


@_query("op2_quality_rules", rules.oracle())
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(documents(spark, sf_dir))


@_query("op3_ngram_jaccard_join", jaccard.oracle())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir))


@_query("op4_imatch_fingerprints")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprinted(documents(spark, sf_dir))


@_query("op5_best_fit_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir))


@_query("op6_source_mixing", mixing.oracle())
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


@_query("op7_warc_fixity", fixity.oracle())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixity.audited(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@_query("op8_html_extraction")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@_query("op9_personal_data")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.digest(documents(spark, sf_dir))


@_query("op10_license_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(documents(spark, sf_dir))


@_query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.summarised(periods.detect(periods.planted(documents(spark, sf_dir))))


@_query("op12_conversation_trie", conversations.oracle())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversations.turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return conversations.trie(conversations.rebuilt(turns))


@_query("op13_exact_top_k", topk.oracle())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
