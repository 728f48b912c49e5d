"""One query per operator, over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tandem.llm import bpe, chat, exact, licences, pages, pieces, quality, repeats, resample, simhash, tiling, toxicity, whitening
from tandem.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """The public vocabulary the token queries use; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_repeated_strings")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(table(spark, sf_dir, "documents"))


@query("op2_bpe_round_trip")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_file())


@query("op3_benchmark_decontamination")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tiling.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "coverage", "n_tiles")


@query("op4_simhash_near_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


@query("op5_exact_dedup", exact.SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.groups(table(spark, sf_dir, "documents"))


@query("op6_chat_format", chat.SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations are trees in which each turn replies to the one before."""
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "\\### Assistant: </turn> ok"
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    nodes = said.unionByName(planted).withColumn("node", F.row_number().over(order))
    return chat.digests(
        chat.conversations(
            nodes.select(
                F.col("conv_id").alias("tree"), "node", (F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")
            )
        )
    )


@query("op7_html_main_text")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(table(spark, sf_dir, "pages"))


@query("op8_licence_scan", licences.SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


@query("op9_quality_score")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_toxicity_score")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op11_embedding_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.by_component(table(spark, sf_dir, "embeddings"))


@query("op12_importance_resampling")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_piece_round_trip")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))
