"""Session settings, plan-size checks and lineage cuts."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(master: str | None = None, app: str = "tandem", **conf) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE, Arrow)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for name, value in conf.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def plan_bytes(df: DataFrame) -> int:
    """Bytes of all tables a plan reads; sources of unknown size report a huge number.

    Catalyst's own estimate multiplies the two sides of a join, which says
    little about key lookups, so the leaves are added up instead. Nothing runs.
    """
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def balanced(scan: DataFrame, key: str) -> DataFrame:
    """A plain scan, spread over all cores by ``key`` when its files give too few tasks.

    Long texts in few row groups would otherwise be cut up by one task. With
    enough splits, as on any large table, the scan is left as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores, key)


def small_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A few driver-side rows (coefficients, grids) as a table of known size.

    The rows are one JSON literal, so plans that join them keep a size estimate;
    a table made from a Python list would count as unknown.
    """
    text = F.lit(json.dumps(rows))
    return spark.range(1).select(F.inline(F.from_json(text, f"array<struct<{schema}>>")))


def scratch(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    A private one is made, and set, only where that is unset and everything
    runs on one machine; a cluster without the setting is refused.
    """
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="tandem-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def settle(df: DataFrame, **options) -> DataFrame:
    """Write an intermediate to the scratch folder and read it back; its size is then known."""
    path = f"{scratch(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path, **options)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def released(spark: SparkSession, **conf) -> Iterator[None]:
    """Shuffle files of the queries that run in here go when these end, not when the driver happens to collect its garbage.

    A setting of Spark 4.1; older ones keep the files until then. More settings can be given for as long.
    """
    conf = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", **conf}
    was = {name: spark.conf.get(name, None) for name in conf}
    try:
        for name, value in conf.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in was.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
