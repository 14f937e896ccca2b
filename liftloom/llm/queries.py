"""The registered queries of this package, each over the whole of its table with the settings meant for production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftloom.llm import (
    ann_graph,
    chat_format,
    curriculum,
    cutting_stock,
    impact_topk,
    langid_bloom,
    license_patience,
    pii_crf,
    prefix_trie,
    setsketch_dedup,
    spelling,
    toxicity_cnn,
    url_rules,
)
from liftloom.llm.words import small_batches
from liftloom.session import tune

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return small_batches(tune(spark)).read.parquet(f"{folder}/{name}.parquet")


def op1_graph_search(spark: SparkSession, folder: str) -> DataFrame:
    return ann_graph.nearest(_table(spark, folder, "embeddings"))


def op2_pii_tagger(spark: SparkSession, folder: str) -> DataFrame:
    return pii_crf.detect(_table(spark, folder, "documents"))


def op3_language_bloom(spark: SparkSession, folder: str) -> DataFrame:
    return langid_bloom.identify(_table(spark, folder, "documents"))


def op4_curriculum_mix(spark: SparkSession, folder: str) -> DataFrame:
    return curriculum.mix(_table(spark, folder, "documents"))


def op5_toxicity_cnn(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity_cnn.toxicity(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op6_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    return url_rules.judge(_table(spark, folder, "pages")).drop("rules_run")


def op7_license_patience(spark: SparkSession, folder: str) -> DataFrame:
    return license_patience.scan(_table(spark, folder, "documents"))


def op8_setsketch_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return setsketch_dedup.near_duplicates(_table(spark, folder, "documents"))


def op9_impact_topk(spark: SparkSession, folder: str) -> DataFrame:
    return impact_topk.exact_top(_table(spark, folder, "embeddings"))


def op10_cutting_stock(spark: SparkSession, folder: str) -> DataFrame:
    return cutting_stock.pack(_table(spark, folder, "documents"))


def op11_spelling_gram(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(_table(spark, folder, "documents"))


def op12_prefix_collapse(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.trie(_table(spark, folder, "conversations"))


def op13_chat_events(spark: SparkSession, folder: str) -> DataFrame:
    said = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    probe = spark.range(2).selectExpr("-7L AS conv_id", "id AS turn", "if(id = 0, 'user', 'assistant') AS role").withColumn("text", F.lit(hard))
    log = chat_format.log_of(said.unionByName(probe))
    return chat_format.digests(chat_format.render(chat_format.messages(log)))


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        op1_graph_search,
        op2_pii_tagger,
        op3_language_bloom,
        op4_curriculum_mix,
        op5_toxicity_cnn,
        op6_url_rules,
        op7_license_patience,
        op8_setsketch_dedup,
        op9_impact_topk,
        op10_cutting_stock,
        op11_spelling_gram,
        op12_prefix_collapse,
        op13_chat_events,
    )
}
