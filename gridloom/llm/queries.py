"""Registered queries of the corpus operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from gridloom.llm import bpe, embdedup, lm, mtree, oracles, packing, periodic, pii, quality, simhash, tokenbin, toxicity, urlgraph, variants
from gridloom.llm.common import table


def op1_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"), distinct=True)


def op2_lm_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(table(spark, sf_dir, "documents"))


def op3_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.token_table(table(spark, sf_dir, "documents"))


def op4_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.component_table(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"))


def op7_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op8_embedding_ego(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.neighbours(table(spark, sf_dir, "embeddings"))


def op9_packing_kk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.windows(table(spark, sf_dir, "documents"))


def op10_url_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlgraph.verdicts(table(spark, sf_dir, "pages"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.report(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.report(table(spark, sf_dir, "documents"))


def op13_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.report(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_pii_disclosure,
        op2_lm_bloom,
        op3_token_binary,
        op4_toxicity_ftrl,
        op5_simhash,
        op6_quality_rules,
        op7_bpe_tree,
        op8_embedding_ego,
        op9_packing_kk,
        op10_url_pagerank,
        op11_spelling_variants,
        op12_periodic_runs,
        op13_mtree_topk,
    ]
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
