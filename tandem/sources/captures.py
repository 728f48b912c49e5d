"""Readers of capture folders, labels, readouts, metric and prediction documents."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..checks import CheckFailed, or_fail, require, require_empty, require_unique
from ..functions import graders, text

SIDECAR_STEM = "confidence_off_v2"


def _path() -> Column:
    return F.col("_metadata.file_path")


def _shard() -> Column:
    return F.regexp_extract(_path(), r"\.shard(\d+)\.", 1).cast("int")


def _json(spark: SparkSession, path: str, schema: str, what: str, whole: bool = False) -> DataFrame:
    try:
        return spark.read.schema(schema).option("multiLine", whole).json(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc):
            raise CheckFailed(f"no {what} under {path}") from exc
        raise


def read_meta(spark: SparkSession, folder: str) -> DataFrame:
    """All ``meta.shard*.jsonl`` rows with their shard number; quarantined shards do not match."""
    rows = _json(spark, f"{folder}/meta.shard*.jsonl", schemas.META, "meta.shard*.jsonl")
    return rows.withColumn("shard", _shard())


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, schemas.LABEL, "labels")


def read_sidecar(spark: SparkSession, folder: str, check: bool = True) -> DataFrame | None:
    """Re-scored confidence of all shards, or None if there is none. Duplicate ids are refused."""
    try:
        rows = _json(spark, f"{folder}/{SIDECAR_STEM}.shard*.jsonl", schemas.SIDECAR, "sidecar")
    except CheckFailed:
        return None
    if check:
        require_unique(rows, ["sample_id"], "duplicate sample_id in the sidecar")
    return rows.withColumn("shard", _shard())


def read_readout(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(covered rows, excluded rows)."""
    rows = _json(spark, f"{folder}/readout.jsonl", schemas.READOUT, "readout.jsonl")
    covered = F.coalesce(F.col("covered"), F.lit(False))
    return rows.where(covered), rows.where(~covered)


def read_config(spark: SparkSession, folder: str, shards: DataFrame, schema: str) -> DataFrame:
    """One config per shard: its own file wins field by field over the global one."""
    fields = [f.split()[0] for f in schema.split(",")]
    try:
        whole = _json(spark, f"{folder}/config.json", schema, "config.json", True)
        require(len(whole.take(2)) < 2, f"config.json under {folder} holds more than one document")
    except CheckFailed:
        whole = spark.range(0).selectExpr(*[f"cast(null as string) as {f}" for f in fields])
    whole = whole.select(*[F.col(f).alias(f"__g_{f}") for f in fields])
    try:
        own = _json(spark, f"{folder}/config.shard*.json", schema, "config", True).withColumn("shard", _shard())
    except CheckFailed:
        own = spark.range(0).selectExpr("cast(id as int) as shard", *[f"cast(null as string) as {f}" for f in fields])
    out = shards.join(own, "shard", "left").join(whole, F.lit(True), "left")
    return out.select("shard", *[F.coalesce(F.col(f), F.col(f"__g_{f}")).alias(f) for f in fields])


def read_vectors(spark: SparkSession, folder: str, mode: str = "off") -> DataFrame:
    """(shard, row_pos, layer, vec) from ``activations_thinking_<mode>.shard*.npz``.

    One task reads one shard and emits it in slices.
    """
    require(mode in ("off", "on"), f"mode must be 'off' or 'on', got {mode!r}")
    path = f"{folder}/activations_thinking_{mode}.shard*.npz"
    try:
        files = spark.read.format("binaryFile").load(path)
    except AnalysisException as exc:
        raise CheckFailed(f"no vector shards under {path}") from exc
    files = files.select(F.regexp_extract("path", r"\.shard(\d+)\.", 1).cast("int").alias("shard"), "content")

    def unpack(batches):
        for batch in batches:
            for shard, content in zip(batch["shard"], batch["content"]):
                with np.load(io.BytesIO(content)) as data:
                    cube = data["activations" if "activations" in data.files else data.files[0]]
                rows, layers, _ = cube.shape
                step = max(1, 20_000 // layers)
                for at in range(0, rows, step):
                    part = cube[at : at + step].astype(np.float32)
                    yield pd.DataFrame({
                        "shard": shard,
                        "row_pos": np.repeat(np.arange(at, at + len(part)), layers),
                        "layer": np.tile(np.arange(layers), len(part)),
                        "vec": list(part.reshape(len(part) * layers, -1)),
                    })

    return files.mapInPandas(unpack, "shard int, row_pos bigint, layer int, vec array<float>")


def read_capture(spark: SparkSession, folder: str, mode: str = "off") -> DataFrame:
    """Meta rows joined to their vectors, by position inside the shard.

    Shards must match in number and in rows, else the alignment is refused.
    """
    meta, vectors = read_meta(spark, folder), read_vectors(spark, folder, mode)
    a = meta.groupBy("shard").agg(F.count(F.lit(1)).alias("n_meta"))
    b = vectors.groupBy("shard").agg(F.countDistinct("row_pos").alias("n_vectors"))
    odd = a.join(b, "shard", "full_outer").where(~F.col("n_meta").eqNullSafe(F.col("n_vectors")))
    require_empty(odd, "meta and vector shards do not match", show="shard")
    named = meta.withColumn("row_pos", F.col("dataset_index")).withColumn("__named", F.lit(True))
    met = vectors.join(named, ["shard", "row_pos"], "left")
    # As many rows on both sides, so a meta row without vectors leaves a vector without a meta row.
    found = or_fail(F.col("__named").isNotNull(), F.col("row_pos"), "a vector's position has no meta row")
    return met.withColumn("row_pos", found).drop("__named")


def metric_files(spark: SparkSession, folder: str, schema: str, prefix: str = "") -> DataFrame:
    """One row per metric document with ``run`` (its file name without .json).

    Prediction files never match; transfer files only when asked for by prefix.
    """
    rows = _json(spark, f"{folder}/{prefix}*.json", schema, "metric documents", True)
    name = F.regexp_extract(_path(), r"([^/]+)\.json(?:/[^/]*)?$", 1)
    out = rows.withColumn("run", name).where(~F.endswith(F.col("run"), F.lit(".predictions")))
    return out if prefix else out.where(~F.startswith(F.col("run"), F.lit("transfer__")))


def named_run(df: DataFrame) -> DataFrame:
    """task and target from a ``task__target`` run name, split at the first ``__``."""
    parts = F.split("run", "__", 2)
    return df.withColumn("run_task", parts[0]).withColumn("run_target", F.try_element_at(parts, F.lit(2)))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Nested prediction documents as a long table, for one or several scorers."""
    docs = _json(spark, path, schemas.PREDICTIONS, "predictions", True)
    return flatten_predictions(docs)


def flatten_predictions(docs: DataFrame) -> DataFrame:
    splits = docs.select("target", "source", F.explode("seeds").alias("seed", "node")).select(
        "target", "source", F.col("seed").cast("int").alias("seed"), F.explode("node").alias("split", "s")
    )
    single = F.when(F.col("s.score").isNotNull(), F.create_map(F.lit("score"), F.col("s.score")))
    scorers = F.coalesce(F.col("s.scores"), single)
    zipped = splits.select("target", "source", "seed", "split", "s", F.explode(scorers).alias("scorer", "score")).select(
        "target", "source", "scorer", "seed", "split",
        F.inline(F.arrays_zip(
            F.col("s.sample_id").alias("sample_id"), F.col("s.y").alias("y"),
            F.col("s.correct_off").alias("correct_off"), F.col("s.correct_on").alias("correct_on"),
            F.col("score").alias("score"),
        )),
    )
    return zipped


# Benchmark tables ------------------------------------------------------------------

def benchmark(df: DataFrame, task: str, split: str = "test", index: str = "idx") -> DataFrame:
    """One of five source layouts as (key, question, answer, difficulty, extra).

    Rows whose gold index is missing or out of range are dropped.
    """
    def key(head, last):
        return F.concat_ws("-", F.lit(head), F.lit(split) if isinstance(split, str) else split, last.cast("string"))

    letter = lambda i: F.substring(F.lit(text.LETTERS), i + 1, F.lit(1))
    idx = F.col(index)
    if task == "gsm8k":
        return df.select(
            key("gsm8k", idx).alias("key"), "question", "answer",
            text.difficulty_gsm8k(F.col("answer")).alias("difficulty"),
            graders.solution_gold(F.col("answer")).cast("string").alias("extra"),
        )
    if task == "lsat":
        gold = F.get("gold", F.lit(0)).cast("int")
        return df.where((F.size("gold") > 0) & (gold < 5)).select(
            key("lsat", idx).alias("key"), F.col("query").alias("question"), letter(gold).alias("answer"),
            text.difficulty_lsat(F.col("query")).alias("difficulty"), F.to_json("choices").alias("extra"),
        )
    if task == "math500":
        return df.select(
            key("math500", idx).alias("key"), F.col("problem").alias("question"), "answer",
            text.difficulty_math(F.col("level")).alias("difficulty"), F.col("subject").alias("extra"),
        )
    if task == "mmlu_pro":
        gold = F.col("answer_index").cast("int")
        return df.where((gold < 10) & (gold < F.size("options"))).select(
            key("mmlupro", F.col("question_id")).alias("key"),
            text.render_options(F.col("question"), F.col("options")).alias("question"),
            letter(gold).alias("answer"),
            text.difficulty_mmlu(F.col("question"), F.col("options")).alias("difficulty"),
            F.col("category").alias("extra"),
        )
    if task == "bbh":
        return df.select(
            F.concat_ws("-", F.lit("bbh"), "subtask", idx.cast("string")).alias("key"),
            F.col("input").alias("question"), F.col("target").alias("answer"),
            text.difficulty_bbh(F.col("input")).alias("difficulty"), F.col("subtask").alias("extra"),
        )
    raise CheckFailed(f"unknown benchmark {task!r}")

