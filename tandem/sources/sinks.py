"""Writers: shards, labels with summaries, predictions, report tables."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.labels import label_report, label_report_by, quarantine


def write_shards(df: DataFrame, folder: str, stem: str, shard: str = "shard", suffix: str = "jsonl") -> None:
    """``<folder>/<stem>.shardNN.<suffix>``, one JSON-lines entry per shard.

    All shards are written by one partitioned job; entries are then given their names.
    """
    staged = f"{folder}/_{stem}_{suffix}"
    df.withColumn("__shard", F.col(shard)).drop(shard).write.partitionBy("__shard").json(staged)
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(staged)
    fs = root.getFileSystem(conf)
    for entry in fs.listStatus(root):
        name = entry.getPath().getName()
        if name.startswith("__shard="):
            number = int(name.split("=")[1])
            fs.rename(entry.getPath(), jvm.org.apache.hadoop.fs.Path(f"{folder}/{stem}.shard{number:02d}.{suffix}"))


def write_capture(meta: DataFrame, folder: str, limit: float = 0.2) -> DataFrame:
    """Meta shards, with shards truncated above the limit moved aside; returns the failures."""
    kept, aside, failed = quarantine(meta, limit)
    write_shards(kept, folder, "meta")
    write_shards(aside, folder, "meta", suffix="jsonl.quarantined")
    failed.write.json(f"{folder}/TRUNCATION_FAILURE")
    return failed


def write_vectors(df: DataFrame, folder: str, mode: str, layers: int) -> int:
    """``activations_thinking_<mode>.shardNN.npz`` from (shard, row_pos, vec); returns the rows written.

    A shard is one file of a fixed size by design, written by the task that holds it.
    """
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        flat = np.array(pdf.sort_values("row_pos")["vec"].tolist(), dtype=np.float32)
        buf = io.BytesIO()
        np.savez_compressed(buf, activations=flat.reshape(len(flat), layers, -1))
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        name = f"{root}/activations_thinking_{mode}.shard{int(pdf['shard'].iloc[0]):02d}.npz"
        # A retried task writes the same bytes to the same name.
        with fs.open_output_stream(name) as out:
            out.write(buf.getvalue())
        return pd.DataFrame({"n": [len(flat)]})

    return df.groupBy("shard").applyInPandas(pack, "n bigint").agg(F.sum("n")).first()[0]


def write_labels(labels: DataFrame, path: str) -> None:
    """Labels as JSON lines, the report and its per-difficulty rows beside them."""
    stem = path.removesuffix(".jsonl")
    labels.write.json(path)
    label_report(labels).write.json(f"{stem}.summary.json")
    label_report_by(labels, ["difficulty"]).write.json(f"{stem}.by_difficulty.json")


def write_predictions(preds: DataFrame, path: str) -> None:
    """The long prediction table, one folder per (target, source)."""
    preds.write.partitionBy("target", "source").parquet(path)


def interval_text(mean: Column, lo: Column, hi: Column, missing: str = "[no boot]") -> Column:
    """``0.123 [0.100,0.150]``; without an interval ``0.123 [no boot]``, without a mean ``-``."""
    whole = F.format_string("%.3f [%.3f,%.3f]", mean, lo, hi)
    bare = F.concat(F.format_string("%.3f ", mean), F.lit(missing))
    return F.when(mean.isNull(), "-").when(lo.isNull(), bare).otherwise(whole)


def number_text(value: Column, digits: int = 3) -> Column:
    return F.coalesce(F.when(value.isNotNull(), F.format_string(f"%.{digits}f", value)), F.lit("-"))


def percent_text(value: Column, digits: int = 1) -> Column:
    return number_text(100 * value, digits)


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """A report table as CSV with a header, or as Markdown / plain text lines."""
    if fmt == "csv":
        df.write.csv(path, header=True)
        return
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in df.columns]
    if fmt == "markdown":
        line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
        head = [f"| {' | '.join(df.columns)} |", f"|{'---|' * len(df.columns)}"]
    else:
        line = F.concat_ws("  ", *[F.rpad(c, 22, " ") for c in cells])
        head = ["  ".join(c.ljust(22) for c in df.columns)]
    top = df.sparkSession.createDataFrame([(i, h) for i, h in enumerate(head)], "i long, value string")
    # The rows keep the order they are given in.
    rows = df.select((F.monotonically_increasing_id() + len(head)).alias("i"), line.alias("value"))
    top.unionByName(rows).orderBy("i").select("value").write.text(path)
