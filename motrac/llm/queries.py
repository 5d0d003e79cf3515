"""The queries of this subpackage over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motrac.llm import dedup, licenses, packing, planes, quality, rangejoin, simhash, toxicity, trie, urls
from motrac.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rangejoin.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.plane_round_trip(table(spark, sf_dir, "documents"))


def op4_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.encode_decode(table(spark, sf_dir, "documents"))


def op7_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).drop("score")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    text = F.transform("findings", lambda f: F.concat_ws(":", f["paragraph"].cast("string"), f["family"], F.format_string("%.3f", f["probability"]), F.format_string("%.3f", f["similarity"])))
    return found.withColumn("findings", F.concat_ws(";", text))


def queries() -> dict[str, Query]:
    own = (op1_best_fit_packing, op2_embedding_near_dedup, op3_token_planes, op4_quality_neighbours, op5_simhash_near_dedup, op6_trie_bpe, op7_ordinal_toxicity, op8_url_filter, op9_exact_dedup, op10_license_scan)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op2_embedding_near_dedup": rangejoin.ORACLE_SQL, "op9_exact_dedup": dedup.ORACLE_SQL}
